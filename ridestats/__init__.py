"""Ride-share analytics as Spark DataFrame jobs.

``sources``    star schema loading, table checks, scratch tables, sinks
``functions``  column expressions: tariff, features, hashing, numeric rules
``operators``  reusable distributed operators: quantiles, sampling, ranking,
               nearest neighbours, local outlier factor, isolation forest
``plans``      the analyses: marts, reports, explorer, revenue models,
               anomalies, scenarios, saved artifacts
"""
