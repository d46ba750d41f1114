"""Column functions and driver-side compilers the operators share."""
