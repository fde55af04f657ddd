"""tessera: geospatial tile analytics and corpus preparation on PySpark DataFrames."""
