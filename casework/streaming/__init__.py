"""casework.streaming"""
