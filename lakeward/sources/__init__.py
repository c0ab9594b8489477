"""lakeward.sources"""
