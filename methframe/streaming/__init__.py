"""methframe.streaming"""
