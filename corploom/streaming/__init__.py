"""corploom.streaming"""
