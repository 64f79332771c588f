"""Jobs made of operators, and the domain view of a star schema."""
