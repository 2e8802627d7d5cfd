"""Relational, graph, equilibrium, estimation, subarea, generation, simulation and reporting operators."""
