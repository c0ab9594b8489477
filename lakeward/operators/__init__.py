"""lakeward.operators"""
