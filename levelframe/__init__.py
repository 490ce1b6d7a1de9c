"""Line and region estimation over image frames, and evaluation of such estimators, on Spark DataFrames."""
