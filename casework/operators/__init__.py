"""casework.operators"""
