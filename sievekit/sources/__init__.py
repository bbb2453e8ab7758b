"""sievekit.sources"""
