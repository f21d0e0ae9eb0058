"""fragmill.sources"""
