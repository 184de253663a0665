"""DataFrame operators on genomes, domain pairs, trees and resamples."""
