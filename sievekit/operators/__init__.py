"""sievekit.operators"""
