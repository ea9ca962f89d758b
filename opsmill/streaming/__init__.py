"""opsmill.streaming"""
