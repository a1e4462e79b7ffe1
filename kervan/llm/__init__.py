"""Operators for preparing text and vectors of a training corpus, one module per problem."""
