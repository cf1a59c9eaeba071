"""corploom.functions"""
