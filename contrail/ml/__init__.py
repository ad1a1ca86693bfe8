"""contrail.ml"""
