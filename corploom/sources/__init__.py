"""corploom.sources"""
