"""Training-data operators: one module for each operator, ``queries`` registers them."""
