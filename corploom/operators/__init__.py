"""corploom.operators"""
