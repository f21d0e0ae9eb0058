"""fragmill.functions"""
