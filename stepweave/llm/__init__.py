"""Training-data operators: each module is one operator, none is imported by the rest of the library."""
