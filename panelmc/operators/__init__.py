"""DataFrame operators: reducers over realizations, rules over steps, sampling designs, studies."""
