"""meshframe: block-structured adaptive meshes as ordinary Spark DataFrames."""
