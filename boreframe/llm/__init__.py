"""Operators of a training-data pipeline over a table of documents.

Every operator takes a DataFrame and column names, reads only the columns it
is given (so extra columns, whatever their names, neither clash nor travel)
and returns a new DataFrame.  Nothing outside this subpackage imports it.
"""
