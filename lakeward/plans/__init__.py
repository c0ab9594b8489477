"""lakeward.plans"""
