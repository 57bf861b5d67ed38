"""Complete jobs: the tables a user asks for, composed from the operators."""
