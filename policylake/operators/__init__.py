"""policylake.operators"""
