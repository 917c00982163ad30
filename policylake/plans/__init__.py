"""policylake.plans"""
