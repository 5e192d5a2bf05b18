"""DataFrame-to-DataFrame operators, one module per analytic step."""
