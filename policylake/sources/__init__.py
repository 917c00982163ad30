"""policylake.sources"""
