"""Nightloom: sleep-recording analytics and data preparation on Spark DataFrames.

Sub-packages
------------
operators   relational operators (stage sequences, events, agreement, clocks, readings)
functions   column builders and NumPy kernels
sources     readers and writers
plans       composed detectors and the named queries
streaming   structured-streaming forms
llm         separate add-on; nothing here imports it
"""

__version__ = "0.1.0"
