"""alertloom: network-alert analytics on Spark DataFrames.

Alert tables come in as DataFrames; features, anomaly scores, baseline upkeep,
novel-attack detection and dashboard answers come out as DataFrames.
"""
