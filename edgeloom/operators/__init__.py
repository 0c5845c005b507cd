"""Operators on edge tables: functions from DataFrames to DataFrames."""
