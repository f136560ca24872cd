"""mdloom.sources"""
