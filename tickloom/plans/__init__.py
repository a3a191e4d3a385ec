"""Plans: which outputs a table of features has, frozen before anything is computed."""
