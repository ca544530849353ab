"""Spark-native quality analytics for cell x gene atlases.

Everything is expressed as DataFrame plans; see README.md for the map of modules.
"""
