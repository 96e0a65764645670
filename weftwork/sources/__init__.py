"""Sources: files of many formats as DataFrames.

Texts come through Spark's own readers; formats that hold a tree of parts
(mail, archives, office files) through ``binaryFile`` and one Arrow pass that
yields rows, so a file is the unit of work and nothing passes the driver.
"""
