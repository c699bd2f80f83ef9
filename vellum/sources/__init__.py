"""Readers (files, object stores, JDBC, JSON documents) and sinks."""
