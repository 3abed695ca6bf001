"""Metered-quota analytics as Spark DataFrame operators.

Every operator is a function from DataFrames (and explicit parameters) to a
DataFrame.  Instants are BIGINT epoch microseconds, request cost is BIGINT
pico-dollars, and ``account_id`` leads every key so one job covers one
subscription or millions of them.
"""
