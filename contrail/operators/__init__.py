"""contrail.operators"""
