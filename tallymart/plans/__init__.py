"""Compositions of operators: the cleaning plan and the staged batch jobs."""
