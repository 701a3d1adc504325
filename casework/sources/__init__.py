"""casework.sources"""
