"""Named queries over the operators, and SQL that says what each must return."""
