"""Training-data operators: ten corpus components, their queries and their SQL."""
