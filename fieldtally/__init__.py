"""Observation analytics on Spark: lazy DataFrame operators for geolocated, user-submitted reports."""
