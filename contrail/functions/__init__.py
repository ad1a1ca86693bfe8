"""contrail.functions"""
