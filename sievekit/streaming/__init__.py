"""sievekit.streaming"""
