"""Reading and writing: change folders, applied logs, candidates, bindings, stamps."""
