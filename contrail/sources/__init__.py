"""contrail.sources"""
