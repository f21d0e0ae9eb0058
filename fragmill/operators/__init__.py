"""fragmill.operators"""
