"""policylake.functions"""
