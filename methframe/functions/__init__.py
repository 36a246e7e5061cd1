"""methframe.functions"""
