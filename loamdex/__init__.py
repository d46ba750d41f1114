"""Spark-native search and data processing over source trees and documents."""

__version__ = "0.1.0"
