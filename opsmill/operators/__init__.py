"""opsmill.operators"""
