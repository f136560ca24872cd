"""mdloom.plans"""
