"""lakeward.functions"""
