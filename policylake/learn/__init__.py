"""policylake.learn"""
