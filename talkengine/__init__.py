"""talkengine: a PySpark-native engine for conversation-transcript mining and training-data preparation.

Every public operator takes DataFrames (or Columns) and returns DataFrames (or Columns); plans are declared
with the DataFrame/SQL API so that Catalyst, AQE and Tungsten choose the physical strategy.
"""

__version__ = "0.1.0"
