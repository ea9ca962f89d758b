"""opsmill.sources"""
