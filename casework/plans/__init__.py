"""casework.plans"""
