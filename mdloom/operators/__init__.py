"""mdloom.operators"""
