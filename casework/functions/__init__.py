"""casework.functions"""
