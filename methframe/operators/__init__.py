"""methframe.operators"""
