"""strandlake.streaming"""
