"""methframe.plans"""
