"""Plans composed of the operators: a whole vault load and the catalogue of driver queries."""
