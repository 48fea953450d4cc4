"""Planning of configurations and composition of operators."""
