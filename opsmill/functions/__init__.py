"""opsmill.functions"""
