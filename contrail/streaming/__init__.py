"""contrail.streaming"""
