"""methframe.sources"""
