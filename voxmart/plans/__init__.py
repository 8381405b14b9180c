"""Multi-stage jobs that chain the operators, and the registered queries."""
