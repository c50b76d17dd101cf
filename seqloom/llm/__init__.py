"""Training-data operators, one module for each of the eight problems; queries.py and sql.py register them."""
