"""mdloom.functions"""
