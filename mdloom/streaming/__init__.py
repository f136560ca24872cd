"""mdloom.streaming"""
