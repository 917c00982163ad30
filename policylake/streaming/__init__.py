"""policylake.streaming"""
