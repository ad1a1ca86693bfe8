"""contrail.plans"""
