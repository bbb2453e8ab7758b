"""sievekit.functions"""
