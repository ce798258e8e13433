"""Reports that combine the operators, and the catalogue of registered queries."""
