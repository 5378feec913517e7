"""Freight analytics over Spark DataFrames: KPIs, pricing, routing, documents and telematics."""
