"""lakeward.streaming"""
